"""Report plans over the star schema: reports (A/K/M/X), dashboard summaries
(C), physical layouts (S5/S6/S9) and the report registry (R)."""
