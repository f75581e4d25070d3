"""Importing this module registers every query."""

from verification import events_queries  # noqa: F401
from verification import relational_queries  # noqa: F401
from verification import clinical_queries  # noqa: F401
from verification import model_queries  # noqa: F401
from verification import view_queries  # noqa: F401
