"""Registered queries by family; importing this package fills the registry."""

from keyloom.plans import keyspace, logs, ranked, scalar  # noqa: F401
