"""Where relations come from: files, archives, and documents rendered from tables."""
