"""Storefront and order events to analytics events, as Spark DataFrame jobs."""
