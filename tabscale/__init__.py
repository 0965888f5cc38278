"""tabscale: table analysis operators (load, type, clean, profile, features,
models, A/B tests, causal effects) expressed as Spark DataFrame plans.

Every operator takes a DataFrame and returns a DataFrame. Statistics are
"fitted" with one or two wide aggregate jobs and applied lazily with
``select``; nothing row-sized ever passes through the driver.
"""

__all__ = ["session"]
