"""Catalogues of files as they arrive."""
