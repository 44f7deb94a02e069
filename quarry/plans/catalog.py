"""Importing this module registers every query."""

from quarry.plans import q_tokens  # noqa: F401
from quarry.plans import q_warehouse  # noqa: F401,E402
from quarry.plans import q_profile  # noqa: F401,E402
from quarry.plans import q_features  # noqa: F401,E402
from quarry.plans import q_jobs  # noqa: F401,E402
