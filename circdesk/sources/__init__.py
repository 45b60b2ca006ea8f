"""Where tables come from and where new versions of them go."""
