"""Row-level operators: cleaning (T*), surrogate keys (D6), star build (D*)."""
