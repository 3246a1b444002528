"""Molecules: SMILES, rings, aromaticity, canonical form, properties, substructures, fingerprints."""
