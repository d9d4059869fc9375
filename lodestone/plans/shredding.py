"""Queries of the shredding operator (problem 5)."""

from __future__ import annotations

from ..operators import shred
from ..session import spread, table
from .catalog import query


def _nodes(spark, d):
    return shred.shred_modules(table(spark, d, "modules")).unionByName(shred.shred_payloads(spread(table(spark, d, "raw_modules"))))


@query()
def p5_found(spark, d):
    return _nodes(spark, d).select("module_id", "class_pos", "function_pos", "arg_pos")


@query()
def p5_arguments(spark, d):
    return shred.tables(_nodes(spark, d))["arguments"]


@query()
def p5_functions(spark, d):
    return shred.tables(_nodes(spark, d))["functions"]


#: Rows of the module table alone, which SQL can state with nested unnests.
@query(
    """
    WITH m AS (SELECT module_id, any_value(functions) AS f, any_value(classes) AS c FROM modules GROUP BY module_id),
    cl AS (SELECT module_id, unnest(range(1, len(c) + 1)) AS class_pos, unnest(c) AS x FROM m),
    fn AS (SELECT module_id, 0 AS class_pos, unnest(range(1, len(f) + 1)) AS function_pos, unnest(f) AS x FROM m
           UNION ALL SELECT module_id, class_pos, unnest(range(1, len(x.methods) + 1)), unnest(x.methods) FROM cl WHERE x IS NOT NULL),
    ar AS (SELECT module_id, class_pos, function_pos, unnest(range(1, len(x.args) + 1)) AS arg_pos, unnest(x.args) AS y FROM fn WHERE x IS NOT NULL)
    SELECT module_id, CAST(0 AS BIGINT) AS class_pos, CAST(0 AS BIGINT) AS function_pos, CAST(0 AS BIGINT) AS arg_pos FROM m
    UNION ALL SELECT module_id, class_pos, 0, 0 FROM cl WHERE x IS NOT NULL
    UNION ALL SELECT module_id, class_pos, function_pos, 0 FROM fn WHERE x IS NOT NULL
    UNION ALL SELECT module_id, class_pos, function_pos, arg_pos FROM ar WHERE y IS NOT NULL
    """
)
def p5_module_rows(spark, d):
    return shred.shred_modules(table(spark, d, "modules")).select("module_id", "class_pos", "function_pos", "arg_pos")


@query(
    """
    WITH m AS (SELECT module_id, any_value(imports) AS a, any_value(external_imports) AS b, any_value(exports) AS e, any_value(functions) AS f, any_value(classes) AS c, any_value(interfaces) AS i, any_value(components) AS o FROM modules GROUP BY module_id),
    cl AS (SELECT module_id, unnest(range(1, len(c) + 1)) AS p, unnest(c) AS x FROM m), fn AS (SELECT module_id, unnest(range(1, len(f) + 1)) AS p, unnest(f) AS x FROM m), me AS (SELECT module_id, p, unnest(range(1, len(x.methods) + 1)) AS q, unnest(x.methods) AS y FROM cl WHERE x IS NOT NULL),
    ni AS (SELECT module_id, unnest(range(1, len(i) + 1)) AS p, unnest(i) AS x FROM m), co AS (SELECT module_id, unnest(range(1, len(o) + 1)) AS p, unnest(o) AS x FROM m),
    l AS (SELECT module_id, 'imports' AS list, 0 AS outer_pos, 0 AS inner_pos, unnest(range(1, len(a) + 1)) AS item_pos, unnest(a) AS value, NULL AS type FROM m
      UNION ALL SELECT module_id, 'external_imports', 0, 0, unnest(range(1, len(b) + 1)), unnest(b), NULL FROM m UNION ALL SELECT module_id, 'exports', 0, 0, unnest(range(1, len(e) + 1)), unnest(e), NULL FROM m
      UNION ALL SELECT module_id, 'classes.bases', p, 0, unnest(range(1, len(x.bases) + 1)), unnest(x.bases), NULL FROM cl WHERE x IS NOT NULL UNION ALL SELECT module_id, 'classes.decorators', p, 0, unnest(range(1, len(x.decorators) + 1)), unnest(x.decorators), NULL FROM cl WHERE x IS NOT NULL
      UNION ALL SELECT module_id, 'functions.decorators', p, 0, unnest(range(1, len(x.decorators) + 1)), unnest(x.decorators), NULL FROM fn WHERE x IS NOT NULL UNION ALL SELECT module_id, 'classes.methods.decorators', p, q, unnest(range(1, len(y.decorators) + 1)), unnest(y.decorators), NULL FROM me WHERE y IS NOT NULL
      UNION ALL SELECT module_id, 'components.hooks', p, 0, unnest(range(1, len(x.hooks) + 1)), unnest(x.hooks), NULL FROM co WHERE x IS NOT NULL
      UNION ALL SELECT module_id, 'interfaces.members', p, 0, n, mb.name, mb.type FROM (SELECT module_id, p, unnest(range(1, len(x.members) + 1)) AS n, unnest(x.members) AS mb FROM ni WHERE x IS NOT NULL) WHERE mb IS NOT NULL)
    SELECT * FROM l WHERE value IS NOT NULL OR list = 'interfaces.members'
    """
)
def p5_lists(spark, d):
    return shred.shred_lists(table(spark, d, "modules"))
