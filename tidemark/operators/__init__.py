"""Transforms from DataFrame to DataFrame: no actions inside, but for checks that must fail loudly."""
