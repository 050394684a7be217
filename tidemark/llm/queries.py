"""All registered queries of this subpackage and their SQL, as far as SQL can express them."""

from tidemark.llm.tables import ORACLES, QUERIES  # noqa: F401
from tidemark.llm import queries_a, queries_b, queries_c  # noqa: F401
