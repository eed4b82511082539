from scourframe.functions import hashing, names, scalars

__all__ = ["hashing", "names", "scalars"]
