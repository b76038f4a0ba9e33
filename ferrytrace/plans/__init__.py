"""Whole deliveries, and the registered queries with their SQL counterparts."""
