"""All queries over the test tables, by name, and their SQL."""

from __future__ import annotations

from trailnote.plans import adopted, lives, notebook, processes, trajectories

QUERIES: dict = {}
ORACLE: dict = {}
for _pack in (trajectories.pack, processes.pack, notebook.pack, lives.pack, adopted.pack):
    QUERIES |= _pack.queries
    ORACLE |= _pack.oracle
