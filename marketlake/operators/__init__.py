"""DataFrame operators: ``cdc`` (decode/route/project change messages),
``versioned`` (latest version, merge, patch, compaction), ``catalog``,
``orders``, ``search``, ``quality`` and ``lookups``. Every function takes and
returns DataFrames/Columns; none collects data to the driver."""
