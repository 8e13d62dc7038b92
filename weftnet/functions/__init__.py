"""Functions of grids: quantics transforms, caching, cross interpolation, Chebyshev interpolation."""
