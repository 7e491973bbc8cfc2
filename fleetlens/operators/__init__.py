"""DataFrame operators of the telemetry jobs."""
