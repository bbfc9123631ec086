"""Ready-made plans: every operator applied to an inventory derived from sales tables."""
