"""Structured Streaming jobs over the same operators."""

from .entries import current_entries, stream_entries
from .orders import distinct_orders, order_day_sums, stream_kpi, stream_kpi_result, stream_orders

__all__ = ["current_entries", "distinct_orders", "order_day_sums", "stream_entries",
           "stream_kpi", "stream_kpi_result", "stream_orders"]
