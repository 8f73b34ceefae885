"""Readers and writers: csv, npy, images, idx, labelled texts, and named tensors."""
