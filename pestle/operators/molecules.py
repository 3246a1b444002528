"""Molecule operators over a table with a SMILES column; invalid SMILES give null and never stop a job."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from pestle.chem import descriptors as d
from pestle.chem.molecule import Molecule, SmilesError, parse_smiles
from pestle.chem.smarts import Query


#: Results that a task remembers by SMILES, so that repeated structures are read once.
REMEMBERED = 50_000


def _remembering(f: Callable[[Molecule], object], bad):
    known: dict[str, object] = {}

    def value(text: str | None):
        if text is None:
            return bad
        if text not in known:
            if len(known) >= REMEMBERED:
                known.clear()
            try:
                known[text] = f(parse_smiles(text))
            except (SmilesError, RecursionError):
                known[text] = bad
        return known[text]

    return value


def _map(f: Callable[[Molecule], object], returns: str):
    """A vectorised function SMILES -> value; null where the text is not a molecule."""

    @F.pandas_udf(returns)
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        value = _remembering(f, None)
        for s in batches:
            yield pd.Series([value(text) for text in s], dtype=object)

    return run


def _struct(f: Callable[[Molecule], dict], schema: str):
    @F.pandas_udf(schema)
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        names = [x.split()[0] for x in schema.split(", ")]
        value = _remembering(f, {})
        for s in batches:
            yield pd.DataFrame([[r.get(n) for n in names] for r in map(value, s)], columns=names).convert_dtypes()

    return run


def with_properties(df: DataFrame, smiles: str = "smiles") -> DataFrame:
    """All properties as columns; each molecule is read once."""
    out = df.withColumn("__p", _struct(d.properties, d.PROPERTY_SCHEMA)(F.col(smiles)))
    return out.select(*df.columns, "__p.*")


def with_canonical(df: DataFrame, smiles: str = "smiles", name: str = "unique_smiles") -> DataFrame:
    return df.withColumn(name, _map(lambda m: m.smiles(), "string")(F.col(smiles)))


def unique_molecules(df: DataFrame, order: str, smiles: str = "smiles", largest_fragment: bool = False) -> DataFrame:
    """The first row of each structure; rows that are no molecules stay."""
    f = (lambda m: d.largest_fragment(m).smiles()) if largest_fragment else (lambda m: m.smiles())
    keyed = df.withColumn("__u", F.coalesce(_map(f, "string")(F.col(smiles)), F.concat(F.lit("?"), F.col(order).cast("string"))))
    w = W.partitionBy("__u").orderBy(order)
    return keyed.withColumn("__n", F.row_number().over(w)).filter("__n = 1").drop("__n", "__u")


def common_structures(a: DataFrame, b: DataFrame, smiles: str = "smiles") -> DataFrame:
    """Rows of ``a`` whose structure is in ``b``."""
    other = with_canonical(b, smiles, "__u").filter("__u IS NOT NULL").select("__u").distinct()
    return with_canonical(a, smiles, "__u").join(other, "__u", "left_semi").drop("__u")


def substructure_counts(df: DataFrame, queries: dict[str, str], smiles: str = "smiles", overlap: bool = True) -> DataFrame:
    """One column of unique match counts for each named query; without ``overlap`` matches share no atom."""
    schema = ", ".join(f"{k} int" for k in queries)

    def count(m: Molecule, built={}) -> dict:  # noqa: B006  a worker's cache
        for k, v in queries.items():
            if k not in built:
                built[k] = Query(v)
        return {k: built[k].count(m, overlap=overlap) for k in queries}

    out = df.withColumn("__q", _struct(count, schema)(F.col(smiles)))
    return out.select(*df.columns, "__q.*")


def substructure_filter(df: DataFrame, query: str, smiles: str = "smiles", least: int = 1, invert: bool = False) -> DataFrame:
    hit = F.coalesce(F.col("__hits") >= least, F.lit(False))
    return substructure_counts(df, {"__hits": query}, smiles).filter(~hit if invert else hit).drop("__hits")


def with_scaffold(df: DataFrame, smiles: str = "smiles") -> DataFrame:
    return df.withColumn("scaffold", _map(lambda m: d.scaffold(m).smiles(), "string")(F.col(smiles)))


def with_largest_fragment(df: DataFrame, smiles: str = "smiles") -> DataFrame:
    return df.withColumn(smiles, _map(lambda m: d.largest_fragment(m).smiles(), "string")(F.col(smiles)))


def with_fingerprint(df: DataFrame, kind: str = "circular", nbits: int = 1024, smiles: str = "smiles", name: str = "fp") -> DataFrame:
    """Folded dense fingerprints as 32-bit words in bigints."""
    make = d.KINDS[kind]
    return df.withColumn(name, _map(lambda m: d.folded(make(m), nbits), "array<bigint>")(F.col(smiles)))


def with_sparse_fingerprint(df: DataFrame, kind: str = "circular", smiles: str = "smiles", name: str = "bits") -> DataFrame:
    make = d.KINDS[kind]
    return df.withColumn(name, _map(lambda m: dict(make(m)), "map<bigint,int>")(F.col(smiles)))


def common_names(df: DataFrame, id_col: str, smiles: str = "smiles", separator: str = ":") -> DataFrame:
    """One row for each structure with the names that share it."""
    u = with_canonical(df, smiles, "unique_smiles").filter("unique_smiles IS NOT NULL")
    return u.groupBy("unique_smiles").agg(F.count("*").alias("n"), F.array_join(F.array_sort(F.collect_set(F.col(id_col).cast("string"))), separator).alias("names"))


def activity_consistency(df: DataFrame, value: str, tolerance: float, smiles: str = "smiles") -> DataFrame:
    """Per structure: count, mean and range of its activities, and whether the range is within the tolerance."""
    u = with_canonical(df, smiles, "unique_smiles").filter("unique_smiles IS NOT NULL").groupBy("unique_smiles")
    out = u.agg(F.count(value).alias("n"), F.avg(value).alias("mean"), (F.max(value) - F.min(value)).alias("range"))
    return out.withColumn("consistent", F.coalesce(F.col("range") <= tolerance, F.lit(True)))


def explode_fragments(df: DataFrame, smiles: str = "smiles") -> DataFrame:
    """One row for each disconnected part of each molecule."""

    def parts(m: Molecule) -> list[str]:
        groups: dict[int, list[int]] = {}
        for i, f in enumerate(m.fragments):
            groups.setdefault(f, []).append(i)
        return [m.subset(g).smiles() for g in groups.values()]

    return df.withColumn("fragment", F.explode(_map(parts, "array<string>")(F.col(smiles))))


def single_cuts(df: DataFrame, smiles: str = "smiles") -> DataFrame:
    """Every split of a molecule at one single bond outside rings: ``context`` and ``fragment``, cut marked by ``*``."""

    def cuts(m: Molecule) -> list[dict]:
        out = []
        for k, (a, b, order) in enumerate(m.bonds):
            if order != 1 or k in m.ring_bonds or max(m.fragments) > 0:
                continue
            for keep, gone in ((a, b), (b, a)):
                seen, todo = {keep}, [keep]
                while todo:
                    for j, _ in m.adjacent[todo.pop()]:
                        if j not in seen and j != gone:
                            seen.add(j)
                            todo.append(j)
                sides = []
                for atoms, end in ((sorted(seen), keep), ([i for i in range(len(m)) if i not in seen], gone)):
                    part = m.subset(atoms)
                    if part.explicit_h[atoms.index(end)] is not None:
                        part.explicit_h[atoms.index(end)] -= 1
                    star = part.add_atom("*", h=0)
                    part.add_bond(atoms.index(end), star, 1)
                    sides.append(part.smiles())
                out.append({"context": sides[0], "fragment": sides[1]})
        return out

    exploded = df.withColumn("__c", F.explode(_map(cuts, "array<struct<context:string,fragment:string>>")(F.col(smiles))))
    return exploded.select(*df.columns, "__c.context", "__c.fragment").distinct()


def matched_pairs(df: DataFrame, id_col: str, value: str, smiles: str = "smiles") -> DataFrame:
    """Molecules that differ by one fragment at one place: ``context, left_id, right_id, left, right, difference``.

    A context that most molecules share gives many pairs by definition; the join is on the context alone and
    adaptive execution splits it.
    """
    c = single_cuts(df.select(id_col, value, smiles), smiles)
    side = lambda x: c.select("context", F.col(id_col).alias(f"{x}_id"), F.col("fragment").alias(x), F.col(value).alias(f"v_{x}"))
    both = side("left").join(side("right"), "context").filter("left < right")
    return both.select("context", "left_id", "right_id", "left", "right", (F.col("v_right") - F.col("v_left")).alias("difference"))


def pair_transforms(pairs: DataFrame) -> DataFrame:
    """Per exchange of fragments: count, mean and spread of the differences, and shares that rise and fall."""
    d = F.col("difference")
    return pairs.groupBy("left", "right").agg(F.count("*").alias("n"), F.avg(d).alias("mean"), F.stddev_samp(d).alias("sd"), (F.count_if(d > 0) / F.count("*")).alias("rises"), (F.count_if(d < 0) / F.count("*")).alias("falls"))


def rule_of_five(df: DataFrame, smiles: str = "smiles") -> DataFrame:
    """Violations among weight over 500, more than 5 donors, more than 10 acceptors."""
    p = with_properties(df.select(*df.columns), smiles)
    return p.select(*df.columns, ((F.col("weight") > 500).cast("int") + (F.col("donors") > 5).cast("int") + (F.col("acceptors") > 10).cast("int")).alias("violations"))


def sort_by_properties(df: DataFrame, keys: list[str], smiles: str = "smiles", tie: str | None = None) -> DataFrame:
    """Order by properties; a leading ``-`` turns a key round."""
    p = with_properties(df, smiles)
    order = [F.col(k[1:]).desc_nulls_last() if k.startswith("-") else F.col(k).asc_nulls_last() for k in keys]
    return p.orderBy(*order, *([tie] if tie else [])).select(*df.columns)
