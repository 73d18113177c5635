"""DataFrame operators.

Rows of a change log carry their document as plain columns next to a few reserved columns, so
filters and projections on document fields reach the file scan:

``__op``      create, update, delete, truncate or schema; null for full-table rows
``__table``   table name, ``__schema`` its schema
``__lsn``     sortable position in the log
``__old``     image before an update, where the log has one (struct)
``__errors``  messages of the steps this row failed
``__unchanged``  names of the fields an update left out because they did not change
"""

OP, TABLE, SCHEMA, LSN, OLD, ERRORS = "__op", "__table", "__schema", "__lsn", "__old", "__errors"
UNCHANGED = "__unchanged"


def is_meta(name: str) -> bool:
    return name.startswith("__")
