"""Training-data operators (tokenising, joins, decontamination, scoring, ...).

Nothing else in the library imports this subpackage.  ``queries`` holds the
registered queries and ``oracle`` the SQL that checks them.
"""
