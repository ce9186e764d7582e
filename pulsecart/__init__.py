"""Retail activity and order analytics on Spark DataFrames and Structured Streaming."""

from pulsecart.session import build_session, configure

__all__ = ["build_session", "configure"]
