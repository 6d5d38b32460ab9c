"""Where raw logs come from and where structured rows are kept."""
