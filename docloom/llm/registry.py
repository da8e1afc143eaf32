"""The queries of this subpackage and, where SQL can express one, its oracle."""

from __future__ import annotations

from .decontaminate import OP3_SQL, op3_decontamination
from .divergence import OP11_SQL, op11_divergence
from .gif import op6_gif
from .idpacking import op5_token_ids
from .langid import op1_language
from .linededup import OP12_SQL, op12_lines
from .minhash import op4_near_duplicates
from .paragraphs import op2_paragraphs
from .passages import op2_passages
from .pii import op10_pii
from .sharding import op7_sharding
from .spelling import op13_spelling
from .spm import op8_sentencepiece
from .urlfilter import OP9_SQL, op9_url_filter


def queries():
    return {"op1_language": op1_language, "op2_paragraphs": op2_paragraphs, "op2_passages": op2_passages, "op3_decontamination": op3_decontamination, "op4_near_duplicates": op4_near_duplicates, "op5_token_ids": op5_token_ids, "op6_gif": op6_gif, "op7_sharding": op7_sharding, "op8_sentencepiece": op8_sentencepiece, "op9_url_filter": op9_url_filter, "op10_pii": op10_pii, "op11_divergence": op11_divergence, "op12_lines": op12_lines, "op13_spelling": op13_spelling}


def oracle_sql():
    return {"op3_decontamination": OP3_SQL, "op9_url_filter": OP9_SQL, "op11_divergence": OP11_SQL, "op12_lines": OP12_SQL}

