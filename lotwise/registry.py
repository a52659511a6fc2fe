"""The queries of the library and the SQL that gives the same rows."""

from __future__ import annotations

from .operators import catalog, fields, fit, fragments, history, lines, lists, market, matching, names, offers, pages, passes, pictures, popups, products, screenshots, similarity, sitemaps, tiles, views
from .plans import board
from .streaming import history as stock_history
from .streaming import products as product_state
from .streaming import stock

QUERIES: dict = {}
ORACLES: dict = {}
for part in (board, names, fields, catalog, market, offers, fit, products, history, matching, similarity, tiles, pages, passes, pictures, popups, screenshots, sitemaps, views, fragments, lines, lists, stock, product_state, stock_history):
    QUERIES.update(part.QUERIES)
    ORACLES.update(part.ORACLES)
