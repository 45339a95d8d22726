"""python -m sparkloom.llm: the same commands for the queries of this subpackage."""

from __future__ import annotations

from sparkloom.__main__ import main
from sparkloom.llm.queries import QUERIES

if __name__ == "__main__":
    raise SystemExit(main(queries=QUERIES))
