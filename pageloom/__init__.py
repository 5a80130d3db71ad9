"""pageloom: raw web pages in, typed tables out, as Spark jobs.

A declarative site description names resources (row selectors, fields, value
transforms, pagination); each becomes a lazily evaluated DataFrame over a table
of pages.  Around that sit crawl-planning jobs over URL tables and structure
inference over page trees.
"""

import sys

from pyspark import cloudpickle

# Functions that run inside Python tasks travel with the job, so executors
# need no installed copy of this package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

from pageloom.hooks import Hooks, hook_transform, load_hooks  # noqa: E402
from pageloom.site import Site  # noqa: E402
from pageloom.spec import SiteSpec, SpecError, load_spec, parse_spec  # noqa: E402

__all__ = [
    "Hooks",
    "Site",
    "SiteSpec",
    "SpecError",
    "hook_transform",
    "load_hooks",
    "load_spec",
    "parse_spec",
]
