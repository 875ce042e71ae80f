"""All registered queries, by area."""

from tripweave.catalog import cleaning, exploration, files, flows, forecast, geometry, network, panels, peaks, storage  # noqa: F401
from tripweave.catalog.base import ORACLES, QUERIES  # noqa: F401
