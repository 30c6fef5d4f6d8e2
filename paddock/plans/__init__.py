"""All registered queries; importing this package registers them."""

from paddock.plans import datasets, exotic, flagship, grids, history, ingesting, modelling, normalizing, odds, quality, reports, rules, splits, state  # noqa: F401
