"""Queries of the molecule operators. Driver tables hold no structures: each part stands for one of a fixed list."""

from __future__ import annotations

from pyspark.sql import functions as F

from pestle.operators import molecules as m
from pestle.operators import similarity as s
from pestle.registry import query, table

#: (SMILES, number of the structure, formula, atoms, rings, aromatic atoms); some structures are written twice.
LIST = [
    ("C", 0, "CH4", 1, 0, 0), ("CC", 1, "C2H6", 2, 0, 0), ("c1ccccc1", 2, "C6H6", 6, 1, 6), ("C1=CC=CC=C1", 2, "C6H6", 6, 1, 6),
    ("OCC", 3, "C2H6O", 3, 0, 0), ("CCO", 3, "C2H6O", 3, 0, 0), ("c1ccc2ccccc2c1", 4, "C10H8", 10, 2, 10), ("CC(=O)Oc1ccccc1C(=O)O", 5, "C9H8O4", 13, 1, 6),
    ("OC(=O)c1ccccc1OC(C)=O", 5, "C9H8O4", 13, 1, 6), ("Cn1cnc2c1c(=O)n(C)c(=O)n2C", 6, "C8H10N4O2", 14, 2, 9), ("[nH]1cccc1", 7, "C4H5N", 5, 1, 5),
    ("NCC(=O)O", 8, "C2H5NO2", 5, 0, 0), ("C1CCCCC1", 9, "C6H12", 6, 1, 0), ("CN1CCCC1c1cccnc1", 10, "C10H14N2", 12, 2, 6), ("O=[N+]([O-])c1ccccc1", 11, "C6H5NO2", 9, 1, 6),
    ("CC(C)Cc1ccc(cc1)C(C)C(=O)O", 12, "C13H18O2", 15, 1, 6), ("Clc1ccc(Cl)cc1", 13, "C6H4Cl2", 8, 1, 6), ("c1ccsc1", 14, "C4H4S", 5, 1, 5), ("N#Cc1ccccc1", 15, "C7H5N", 8, 1, 6),
]
VALUES = ", ".join(f"({i}, {n}, '{f}', {a}, {r}, {ar})" for i, (_, n, f, a, r, ar) in enumerate(LIST))
JOINED = f"(SELECT p_partkey, v.* FROM part JOIN (VALUES {VALUES}) v(i, structure, formula, natoms, nrings, aromatic_atoms) ON v.i = p_partkey % {len(LIST)})"


def structures(spark, sf):
    known = F.array(*[F.lit(x[0]) for x in LIST])
    return table(spark, sf, "part").select("p_partkey", F.element_at(known, (F.col("p_partkey") % len(LIST) + 1).cast("int")).alias("smiles"))


@query("e_properties", f"SELECT p_partkey, formula, natoms, nrings, aromatic_atoms FROM {JOINED}")
def e_properties(spark, sf):
    return m.with_properties(structures(spark, sf)).select("p_partkey", "formula", "natoms", "nrings", "aromatic_atoms")


@query("e_unique_molecules", f"SELECT min(p_partkey) AS p_partkey FROM {JOINED} GROUP BY structure")
def e_unique_molecules(spark, sf):
    return m.unique_molecules(structures(spark, sf), "p_partkey").select("p_partkey")


@query("e_molecule_filter", f"SELECT p_partkey FROM {JOINED} WHERE natoms >= 6 AND nrings <= 1 AND aromatic_atoms > 0")
def e_molecule_filter(spark, sf):
    from pestle.operators.tables import filter_rows

    return filter_rows(m.with_properties(structures(spark, sf)), "natoms>=6&&nrings<=1&&aromatic_atoms>0").select("p_partkey")


@query("e_substructure", f"SELECT p_partkey FROM {JOINED} WHERE structure IN (5, 8, 12)")
def e_substructure(spark, sf):
    return m.substructure_filter(structures(spark, sf), "[CX3](=O)[OX2H]").select("p_partkey")


@query("e_common_structures", f"SELECT p_partkey FROM {JOINED} WHERE p_partkey % 2 = 0 AND structure IN (SELECT structure FROM {JOINED} WHERE p_partkey % 2 = 1)")
def e_common_structures(spark, sf):
    x = structures(spark, sf)
    return m.common_structures(x.filter("p_partkey % 2 = 0"), x.filter("p_partkey % 2 = 1")).select("p_partkey")


@query("e_scaffolds")
def e_scaffolds(spark, sf):
    return m.with_scaffold(structures(spark, sf)).groupBy("scaffold").agg(F.count("*").alias("n"))


@query("e_fingerprint_neighbours")
def e_fingerprint_neighbours(spark, sf):
    x = m.unique_molecules(structures(spark, sf), "p_partkey")
    f = s.saved(m.with_fingerprint(x).select(F.col("p_partkey").alias("id"), "fp"))
    return s.nearest(f, f, 3).withColumn("distance", F.round("distance", 6))
