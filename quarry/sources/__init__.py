"""Readers of source trees and of project settings."""
