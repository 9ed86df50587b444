"""All registered queries (importing the modules fills the registry)."""
from tillflow.plans import description, evaluation, preparation, text  # noqa: F401
from tillflow.plans.registry import QUERIES  # noqa: F401
