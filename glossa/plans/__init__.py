"""What runs operators: the registry, execution, benchmarks, experiments, advice and registered queries."""
