"""Registered queries over the test tables, each with its SQL counterpart."""

from checks import models, policy, tables  # noqa: F401
from checks.base import ORACLES, QUERIES  # noqa: F401
