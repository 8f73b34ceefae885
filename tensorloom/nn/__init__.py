"""Reverse-mode differentiation, layers, losses and optimizers.

Parameters are small NumPy arrays on the driver; batches of a DataFrame are
evaluated on executors, and only summed gradients come back.
"""
