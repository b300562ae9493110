"""Everything under one name: ``from tidymesh import api as tm``."""

from tidymesh.expr import aggregate, scalar, window  # noqa: F401
from tidymesh.models.compose import *  # noqa: F403
from tidymesh.models.core import *  # noqa: F403
from tidymesh.models.evaluate import *  # noqa: F403
from tidymesh.models.fit import *  # noqa: F403
from tidymesh.models.library import *  # noqa: F403
from tidymesh.models.marginals import *  # noqa: F403
from tidymesh.streaming.apply import *  # noqa: F403
from tidymesh.transforms.charts import *  # noqa: F403
from tidymesh.transforms.pareto import *  # noqa: F403
from tidymesh.transforms.spc import *  # noqa: F403
from tidymesh.transforms.statistics import *  # noqa: F403
from tidymesh.verbs import *  # noqa: F403

#: The decorator for functions of one's own: of columns, so that they take expressions too.
make_symbolic = scalar
