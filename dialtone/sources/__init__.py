"""Where tables come from and where marts and reports go."""
