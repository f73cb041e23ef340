"""Registered queries: name -> callable, and the SQL that checks them."""
