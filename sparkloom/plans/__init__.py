"""Registered queries: every operator applied to whole tables, with the SQL that checks it.

The supplied tables stand in for the library's own: orders for evidence, lineitem for mentions and originators, part for chapters,
customer and supplier for actors, nation and region for places, events for snapshots, documents for posts, labels for reviews.
"""

from sparkloom.plans import browse, files, merge, pages, people, posts, text, topics, values  # noqa: F401
