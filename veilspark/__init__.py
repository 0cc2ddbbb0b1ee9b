"""Find, mask, restore and compare sensitive data with Spark."""
