"""Small SQL fragments used by the checking texts."""

from __future__ import annotations


def pcc(x: str, y: str, where: str = "TRUE", floor: str = "1e-16") -> str:
    """Correlation that is NULL below two rows or without spread."""
    both = f"({x}) IS NOT NULL AND ({y}) IS NOT NULL AND ({where})"
    px, py = f"CASE WHEN {both} THEN ({x}) END", f"CASE WHEN {both} THEN ({y}) END"
    return (
        f"CASE WHEN count({px}) >= 2 AND var_pop({px}) > {floor} AND var_pop({py}) > {floor} "
        f"THEN covar_pop({px}, {py}) / sqrt(var_pop({px}) * var_pop({py})) END"
    )


def r2(p: str, t: str, rows: int = 2, floor: str = "1e-8") -> str:
    """Coefficient of determination that is NULL without spread."""
    return (
        f"CASE WHEN count({t}) >= {rows} AND var_pop({t}) * count({t}) > {floor} "
        f"THEN 1 - sum((({p}) - ({t})) * (({p}) - ({t}))) / (var_pop({t}) * count({t})) END"
    )


def response(p: str, t: str, ctx: str = "ctx", drug: str = "drug", zero: bool = False) -> str:
    """The response metrics of one group as rounded SQL columns."""
    ht, hp = f"abs({t}) > 1", f"abs({p}) > 1"
    same = f"sign({p}) = sign({t})"
    hit = f"count(*) FILTER (WHERE {ht} AND {hp} AND {same})"
    n_ht, n_hp = f"count(*) FILTER (WHERE {ht})", f"count(*) FILTER (WHERE {hp})"
    f1 = f"2.0 * {hit} / nullif({n_ht} + {n_hp}, 0)"
    if not zero:
        f1 = f"CASE WHEN {hit} > 0 THEN {f1} END"
    return f"""
       r6({pcc(p, t)}) AS fc_pcc,
       r6({pcc(f'{p} - {ctx}', f'{t} - {ctx}')}) AS context_residual_pcc,
       r6({pcc(f'{p} - {drug}', f'{t} - {drug}')}) AS drug_residual_pcc,
       r6({pcc(p, t, ht)}) AS high_effect_pcc,
       r6(count(*) FILTER (WHERE {ht} AND {same}) * 1.0 / nullif({n_ht}, 0)) AS high_effect_direction_accuracy,
       r6({hit} * 1.0 / nullif({n_hp}, 0)) AS high_effect_precision,
       r6({hit} * 1.0 / nullif({n_ht}, 0)) AS high_effect_recall,
       r6({f1}) AS high_effect_f1"""


def fingerprint(columns: list[str]) -> str:
    """SQL for the multiset fingerprint of the named columns."""
    parts = ", ".join(
        f"'{name}=' || coalesce('''' || CAST({name} AS VARCHAR) || '''', 'null')" for name in sorted(columns)
    )
    return digest_sum(f"sha256(concat_ws(chr(31), {parts}))")


def digest_sum(digest: str) -> str:
    """SQL for the fingerprint of a multiset of sha256 digests."""
    words = ", ".join(
        f"CAST(sum(CAST('0x' || substr({digest}, {1 + 15 * i}, 15) AS BIGINT)) AS VARCHAR)" for i in range(4)
    )
    return f"sha256(concat_ws('-', CAST(count(*) AS VARCHAR), {words}))"
