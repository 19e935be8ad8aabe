"""All queries by name, with their SQL."""

from lexmill.plans import corpora, kernels, speech, texts  # noqa: F401
from lexmill.plans.base import QUERIES, SQL  # noqa: F401
