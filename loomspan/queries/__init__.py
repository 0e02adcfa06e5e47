"""Registered queries, by area: name -> (function of (spark, sf_dir), SQL or None)."""
