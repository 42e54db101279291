"""Column expressions: ratios, labels, decline curves and the curve fit."""
