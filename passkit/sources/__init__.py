"""Sources and sinks: test-bed tables, JSON Lines / JSON readers and writers, dataset catalog."""
