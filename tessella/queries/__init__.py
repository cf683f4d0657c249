"""Registered queries over the supplied tables, with the SQL that checks them."""
