"""DataFrame -> DataFrame operators: scoring, evaluation, requests, measurements, quantiles, ordering, plug-ins, harness."""
