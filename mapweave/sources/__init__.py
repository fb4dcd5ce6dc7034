"""Where records come from, and where prepared tiles and pointers are kept."""
