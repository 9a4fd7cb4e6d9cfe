"""All registered queries of the retrieval engine and their SQL."""

from millrace.plans import dialogue, evaluation, extras, gate, keyed, retrieval, service, structure, surfaces  # noqa: F401
from millrace.plans.base import ORACLE, QUERIES  # noqa: F401
