"""Ways of running a plan: shared scratch tables and fitting loops."""
