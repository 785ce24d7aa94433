"""Structured Streaming jobs: continuous payload ingest and per-cycle scorecards."""
from feedlake.streaming.ingest import land_payloads, stream_ingest  # noqa: F401
from feedlake.streaming.scorecard import stream_scorecard  # noqa: F401
from feedlake.streaming.digests import stream_digests  # noqa: F401,E402
