"""The report: options, orchestration, rendering, the sidecar and differences between two reports."""
