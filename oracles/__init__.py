"""SQL the registered queries must agree with."""

from oracles.business import BUSINESS
from oracles.model import MODEL
from oracles.synthetic import SYNTHETIC
from oracles.texts import TEXTS
from oracles.views import with_views


def oracle_statements() -> dict[str, str]:
    return {
        name: with_views(sql)
        for group in (BUSINESS, MODEL, SYNTHETIC, TEXTS)
        for name, sql in group.items()
    }
