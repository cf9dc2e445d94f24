"""Write COVERAGE.md: survey row -> registered queries.   python tests/coverage_table.py"""

from __future__ import annotations

import sys
from pathlib import Path

ROOT = Path(__file__).resolve().parents[1]
sys.path.insert(0, str(ROOT))


def main() -> None:
    from catalog import load
    from catalog.registry import COVERS, SQL

    load()
    rows: dict[str, list[str]] = {}
    for name, ids in COVERS.items():
        for i in ids:
            rows.setdefault(i, []).append(name + ("" if name in SQL else " (rows only)"))
    order = ["SRC", "SNK", "DET", "NER", "RED", "VLT", "POL", "CNV", "AUD", "ALN", "STR"]
    out = ["# Coverage", "", "Survey row and the registered queries that exercise it; all have exact SQL unless marked.", "", "| Row | Queries |", "|---|---|"]
    for i in sorted(rows, key=lambda x: (order.index(x[:3]), x)):
        out.append(f"| {i} | {', '.join(rows[i])} |")
    out += ["", f"{len(rows)} rows, {len(COVERS)} queries, {len(SQL)} with SQL."]
    (ROOT / "COVERAGE.md").write_text("\n".join(out) + "\n")
    print(out[-1])


if __name__ == "__main__":
    main()
