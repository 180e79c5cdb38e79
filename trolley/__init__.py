"""Basket-conversion analytics over e-commerce click logs, as Spark DataFrame jobs."""

from trolley.schema import Rules

__all__ = ["Rules"]
