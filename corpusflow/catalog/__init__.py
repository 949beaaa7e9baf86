"""Queries over the shared tables, each with the SQL that checks it."""

from corpusflow.catalog import articles, chat, findings, search, snapshots, stored, text  # noqa: F401
from corpusflow.catalog.base import ORACLES, QUERIES  # noqa: F401
