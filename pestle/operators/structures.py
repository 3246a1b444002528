"""Further molecule operators: rewriting SMILES, counts without parsing, parts of structures, symmetry, look-ups."""

from __future__ import annotations

import random

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pestle.chem.molecule import Molecule
from pestle.chem.smarts import Query
from pestle.operators.molecules import _map, with_canonical

#: An atom of a SMILES, bracketed or of the organic subset; aromatic letters are lower case.
ATOM = r"\[[^\]]*\]|Cl|Br|[BCNOPSFI]|[bcnops]"


def count_atoms(smiles: Column) -> Column:
    """Atoms of a SMILES by its text alone, without reading the structure; explicit hydrogens count."""
    return F.regexp_count(smiles, F.lit(ATOM)).cast("long")


def with_random_smiles(df: DataFrame, seed: int, smiles: str = "smiles", name: str = "random_smiles") -> DataFrame:
    """A SMILES of the same structure in an order that the seed and the structure fix."""

    def shuffled(m: Molecule) -> str:
        order = list(range(len(m)))
        random.Random(f"{seed} {m.smiles()}").shuffle(order)
        return m.smiles(order)

    return df.withColumn(name, _map(shuffled, "string")(F.col(smiles)))


def with_numbered_smiles(df: DataFrame, smiles: str = "smiles", name: str = "numbered_smiles", offset: int = 1) -> DataFrame:
    """Every atom's isotope is its number in the input."""

    def numbered(m: Molecule) -> str:
        h = [m.hydrogens(i) for i in range(len(m))]
        aromatic = m.aromatic_atoms  # computed before hydrogens are fixed
        assert aromatic is not None
        m.explicit_h = h
        m.isotope = [i + offset for i in range(len(m))]
        return m.smiles(list(range(len(m))))

    return df.withColumn(name, _map(numbered, "string")(F.col(smiles)))


def with_first_atom(df: DataFrame, query: str, smiles: str = "smiles", name: str = "rooted_smiles") -> DataFrame:
    """A SMILES that starts at the first atom of the query's first match; null without one."""

    def rooted(m: Molecule, built={}) -> str | None:  # noqa: B006  a worker's cache
        q = built.setdefault(query, Query(query))
        hit = q.first(m)
        if hit is None:
            return None
        rank = [r + 1 for r in m.ranks()]
        rank[hit[0]] = 0
        return m.smiles(rank)

    return df.withColumn(name, _map(rooted, "string")(F.col(smiles)))


def with_subset(df: DataFrame, query: str, invert: bool = False, smiles: str = "smiles", name: str = "subset", overlap: bool = True) -> DataFrame:
    """The structure of the atoms that the query matches anywhere, or of all others; null if there are none. Without
    ``overlap`` matches that share an atom with one before are none."""

    def part(m: Molecule, built={}) -> str | None:  # noqa: B006  a worker's cache
        q = built.setdefault(query, Query(query))
        hit = {a for e in (q.embeddings(m) if overlap else q.apart(m)) for a in e}
        keep = [i for i in range(len(m)) if (i in hit) != invert]
        m.kekulise()
        return m.subset(keep).smiles() if keep else None

    return df.withColumn(name, _map(part, "string")(F.col(smiles)))


def with_skeleton(df: DataFrame, smiles: str = "smiles", name: str = "skeleton") -> DataFrame:
    """All atoms carbon, all bonds single: structures of equal connectivity get equal skeletons."""

    def bare(m: Molecule) -> str:
        out = Molecule()
        for _ in range(len(m)):
            out.add_atom("C", h=0)
        for a, b, _ in m.bonds:
            out.add_bond(a, b, 1)
        out.explicit_h = [None if len(out.adjacent[i]) <= 4 else 0 for i in range(len(out))]
        return out.smiles()

    return df.withColumn(name, _map(bare, "string")(F.col(smiles)))


def with_symmetry(df: DataFrame, smiles: str = "smiles", name: str = "symmetry_classes") -> DataFrame:
    """Classes of atoms that neighbourhood refinement does not tell apart."""
    return df.withColumn(name, _map(lambda m: len(set(m.ranks(ties=False))), "long")(F.col(smiles)))


def with_longest_path(df: DataFrame, smiles: str = "smiles", name: str = "longest_path") -> DataFrame:
    """The greatest number of bonds between two atoms of one fragment, on shortest paths."""

    def longest(m: Molecule) -> int:
        best = 0
        for start in range(len(m)):
            seen, layer, depth = {start}, [start], -1
            while layer:
                depth += 1
                layer = list({j for i in layer for j, _ in m.adjacent[i] if j not in seen})
                seen.update(layer)
            best = max(best, depth)
        return best

    return df.withColumn(name, _map(longest, "long")(F.col(smiles)))


def sp3_filter(df: DataFrame, least: float, smiles: str = "smiles") -> DataFrame:
    """Structures of whose carbons at least the share ``least`` has single bonds only."""

    def share(m: Molecule) -> float | None:
        carbons = [i for i in range(len(m)) if m.symbol[i] == "C"]
        single = sum(i not in m.aromatic_atoms and all(m.bonds[k][2] == 1 for _, k in m.adjacent[i]) for i in carbons)
        return single / len(carbons) if carbons else None

    return df.filter(_map(share, "double")(F.col(smiles)) >= least)


def fragment_filter(df: DataFrame, most: int = 1, least_atoms: int = 1, smiles: str = "smiles") -> DataFrame:
    """Structures of at most ``most`` fragments, each of at least ``least_atoms`` atoms."""

    def fine(m: Molecule) -> bool:
        sizes: dict[int, int] = {}
        for f in m.fragments:
            sizes[f] = sizes.get(f, 0) + 1
        return 0 < len(sizes) <= most and min(sizes.values()) >= least_atoms

    return df.filter(_map(fine, "boolean")(F.col(smiles)))


def find_structures(df: DataFrame, needles: DataFrame, smiles: str = "smiles", invert: bool = False) -> DataFrame:
    """Rows whose structure is (or, inverted, is not) among the ``needles``, however either is written."""
    wanted = with_canonical(needles.select(F.col(smiles)), smiles, "__wanted").select("__wanted").distinct()
    found = with_canonical(df, smiles, "__own")
    return found.join(wanted, found["__own"] == wanted["__wanted"], "left_anti" if invert else "left_semi").drop("__own")
