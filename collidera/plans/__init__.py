"""The preparation steps and reports, put together from operators."""
