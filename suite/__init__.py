"""The registered queries and their SQL twins, on the driver's tables."""
