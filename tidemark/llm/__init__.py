"""Training-data operators.

Nothing else in the library imports this subpackage, and it imports nothing
from the rest of the library.
"""
