"""The registered queries, by area."""

from cairnflow.plans import clustering, details, discovery, events, layout, relational, sessions, vectors  # noqa: F401
