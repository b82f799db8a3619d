"""Where records come from."""

from .producer import produced, register_producer
from .publish import Publisher
from .readers import (
    events,
    json_lines,
    json_line_stream,
    order_prices,
    rate,
    replay_log,
    socket_lines,
    text_lines,
    text_line_stream,
    with_heartbeat,
)

__all__ = [
    "Publisher",
    "events",
    "json_line_stream",
    "json_lines",
    "order_prices",
    "produced",
    "rate",
    "register_producer",
    "replay_log",
    "socket_lines",
    "text_line_stream",
    "text_lines",
    "with_heartbeat",
]
