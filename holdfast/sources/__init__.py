"""Reading tables in and writing study results out."""
