"""Readers for fact tables, source trees and tool reports."""
