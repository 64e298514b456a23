"""Column references for names with blanks, dots or brackets."""


def safe(name: str) -> str:
    """A column name ML can read: a dot would mean nesting, a backtick would end the name."""
    return name.replace(".", "_").replace("`", "_")


def quote(name: str) -> str:
    return "`" + name.replace("`", "``") + "`"
