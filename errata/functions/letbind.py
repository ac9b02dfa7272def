"""Bind expressions once per row for use inside higher-order functions.

The optimiser inlines a computed column into a consumer that references it
once, even when that reference sits inside a lambda, where it would then be
evaluated once per array element. Binding values through a one-element
array, ``transform(array(named_struct(...)), v -> body)[0]``, evaluates each
bound value once per row; lambdas refer to ``v.name`` only.
"""

from __future__ import annotations


def sql_str(s: str) -> str:
    """A Spark SQL string literal holding ``s`` exactly."""
    return "'" + s.replace("\\", "\\\\").replace("'", "\\'") + "'"


def let(binds: list[tuple[str, str]], body: str, var: str = "v") -> str:
    fields = ", ".join(f"'{n}', {e}" for n, e in binds)
    return f"transform(array(named_struct({fields})), {var} -> {body})[0]"
