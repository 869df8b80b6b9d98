"""Rows in a form that Spark's and DuckDB's can be compared in."""


def canonical(rows) -> list[str]:
    """Rows of dicts as sorted texts, columns by name, numbers to six places."""

    def text(x):
        if isinstance(x, bool) or x is None:
            return str(x)
        if isinstance(x, (int, float)) or type(x).__name__ == "Decimal":
            return f"{float(x):.6g}" if abs(float(x)) < 1e9 else f"{float(x):.0f}"
        if isinstance(x, (list, tuple)):
            return str([text(y) for y in x])
        return str(x)

    return sorted(str([(k, text(row[k])) for k in sorted(row)]) for row in rows)
