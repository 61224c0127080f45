"""Streaming variant of the ping source (day files arriving in a folder)."""

from transitlens.streaming.stream import observation_stream, read_ping_stream, start

__all__ = ["observation_stream", "read_ping_stream", "start"]
