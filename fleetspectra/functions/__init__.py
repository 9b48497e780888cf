"""Column functions: interval text, array arithmetic, labels."""
