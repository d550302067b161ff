"""sheaf: pack large text and source-code collections into numbered bundles, on Spark."""

from sheaf.options import CleanOptions, PackOptions
from sheaf.plans.pack import pack

__all__ = ["CleanOptions", "PackOptions", "pack"]
