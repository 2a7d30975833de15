"""No streaming operators: the engine's operations are batch ones, and resuming a run is
the business of ``sources.layout.run_blocks``."""
