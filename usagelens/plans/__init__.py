"""The gateway presets: levels, contract checks, metrics, audit and the runs that chain them."""
