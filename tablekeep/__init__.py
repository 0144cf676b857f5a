"""Table governance as Spark jobs: conform, audit, geometry quality, history, registers, reconcile."""
