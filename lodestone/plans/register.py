"""Imports every module of queries, so that the catalog is complete."""

from . import shredding  # noqa: F401
from . import retrieval  # noqa: F401
from . import graphs  # noqa: F401
from . import code  # noqa: F401
from . import ordered, parsing  # noqa: F401
from . import corpus  # noqa: F401
from . import labelled  # noqa: F401
from . import overview, searching, fixtures  # noqa: F401
