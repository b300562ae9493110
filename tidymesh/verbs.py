"""All table verbs, functions and sources under one name: ``from tidymesh import verbs as tm``."""

from tidymesh.expr import DF, X, Expr  # noqa: F401
from tidymesh.functions.aggregates import *  # noqa: F403
from tidymesh.functions.scalar import *  # noqa: F403
from tidymesh.functions.strings import *  # noqa: F403
from tidymesh.functions.windows import *  # noqa: F403
from tidymesh.operators.group import *  # noqa: F403
from tidymesh.operators.join import *  # noqa: F403
from tidymesh.operators.reshape import *  # noqa: F403
from tidymesh.operators.rows import *  # noqa: F403
from tidymesh.operators.select import *  # noqa: F403
from tidymesh.operators.sets import *  # noqa: F403
from tidymesh.sources.frames import *  # noqa: F403
from tidymesh.table import Table, add_pipe, as_table, pipe, verb  # noqa: F401
