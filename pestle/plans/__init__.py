"""Registered query plans; importing the modules fills the registry."""


def load():
    from pestle import registry
    from pestle.plans import chemistry, conversions, expansion, fingerprints, models, records, splits, structures, tabular  # noqa: F401

    return registry
