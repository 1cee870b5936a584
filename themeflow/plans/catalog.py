"""All registered queries (importing a module registers its queries)."""

from themeflow.plans import reports  # noqa: F401
from themeflow.plans import maintenance  # noqa: F401
from themeflow.plans import listings  # noqa: F401
from themeflow.plans import ingestion  # noqa: F401
from themeflow.plans import annotation  # noqa: F401
from themeflow.plans import vector_jobs  # noqa: F401
from themeflow.plans import streaming_jobs  # noqa: F401
from themeflow.plans.registry import REGISTRY  # noqa: F401
