"""Column functions: every one builds an expression that the optimiser can fold, prune and compile."""
