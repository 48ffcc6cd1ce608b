"""innkeep: lodging analytics (directory, search, booking history, command jobs
and data-quality audits) expressed as Spark DataFrame plans."""

__version__ = "0.1.0"
